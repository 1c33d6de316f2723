import random

import numpy as np
import pytest

from tests.llm import brute
from trajlake.llm import _text, periodic_runs


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    x = [0]
    while len(x) < n:
        x += [1 - a for a in x]
    return x[:n]


def blocks(r, n):
    """Highly periodic regions of one root, of many lengths, side by side: their runs have no chosen positions."""
    root, out = [r.randrange(2) for _ in range(r.randrange(1, 5))], []
    while len(out) < n:
        out += (root * 100)[: r.choice([37, 41, 50, r.randrange(1, 80)])]
    return out[:n]


def doubled(r, n):
    out = [0]
    while len(out) < n:
        out += out[-r.randrange(1, len(out) + 1) :] * r.randrange(1, 3)
        out += [r.randrange(3)] * (r.random() < 0.4)
    return out[:n]


def looped(r, n):
    root = [r.randrange(3) for _ in range(r.randrange(1, 60))]
    return [9] + (root * n)[:n] + [8]


@pytest.mark.parametrize("seed", range(6))
def test_find_runs_finds_all_runs(seed):
    r = random.Random(seed)
    for _ in range(12):
        n = r.randrange(1, 400)
        texts = [fibonacci(n), thue_morse(n), blocks(r, n), doubled(r, n), looped(r, n), [r.randrange(2) for _ in range(n)], [1] * n, []]
        line, begin = [], []
        for t in texts:
            begin.append(len(line))
            line += [*t, 1000 + len(line)]
        found = periodic_runs.find_runs(_text.mix(np.array(line, np.uint64)), max(map(len, texts)))
        found = [x.tolist() for x in found]
        assert list(zip(found[0], [e - s for s, e in zip(*found[:2], strict=True)], found[2], strict=True)) == [(b + s, n, q) for b, t in zip(begin, texts, strict=True) for s, n, q in brute.runs(t, 0)]


def test_chosen_positions_are_consistent_and_dense():
    r = random.Random(3)
    words = doubled(r, 500) + [r.randrange(2) for _ in range(1500)] + blocks(r, 300)
    line = np.array(words, np.uint64)
    for scale in (4, 8, 16):
        small = [any(all(words[j] == words[j + p] for j in range(i, i + scale - p)) for p in range(1, scale // 3 + 1)) for i in range(len(words) - scale + 1)]
        chosen = set(periodic_runs.synchronising(periodic_runs.Blocks(_text.mix(line), 512), scale, np.array(small)).tolist())
        context = lambda i: tuple(words[i : i + 2 * scale])
        marked = {context(i) for i in chosen}
        assert {i for i in range(len(words) - 2 * scale + 1) if context(i) in marked} == chosen
        for i in range(len(words) - 3 * scale + 2):
            assert bool(chosen & set(range(i, i + scale))) != all(small[i : i + 2 * scale])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    spell = lambda t: " ".join(["der", "Été", "x", " y", "und"][a] if a < 5 else f"w{a}" for a in t)
    texts = [None, "", " \n\t", "one", "a a", "x " * 40, "go on\n" * 9, spell(looped(r, 25000)), spell([r.randrange(400) for _ in range(6000)])]
    for n in range(20, 220, 4):
        texts += [spell(fibonacci(n)), spell(doubled(r, n)), spell(looped(r, n)), spell([r.randrange(300) for _ in range(n)])]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 40), (-5, "la le " * 12), (3, "one"), (3, "one")]


def test_run_digests(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, start int, collapsed string").repartition(3)
    found = sorted((tuple(r) for r in periodic_runs.run_digests(docs, rewrite=periodic_runs.looped).collect()), key=str)
    long = lambda k, t: len((t or "").split()) > 20000
    assert sum(long(*r) for r in rows) == 1
    assert len(found) == len(rows)
    wanted = sorted(((k, *brute.run_row(k, t)) for k, t in rows if not long(k, t)), key=str)
    skipped = [k for k, t in rows if long(k, t)]
    assert [r for r in found if r[0] not in skipped] == wanted
    longest = next(r for r in found if r[0] in skipped)
    assert longest[1] > 0 and longest[3] >= 8000
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b c " * 6 + "d"), (2, None), (None, "x  y\n" * 8), (4, "no run here")], "doc_id long, text string")
    found = {tuple(r) for r in periodic_runs.periodic_runs(docs).collect()}
    assert found == {(1, 0, 18, 3), (None, 0, 16, 2)}
    texts = {r.doc_id: r.collapsed for r in periodic_runs.collapse_runs(docs).collect()}
    assert texts == {1: "a b c d", 2: "", None: "x y", 4: "no run here"}
    assert {tuple(r) for r in periodic_runs.periodic_runs(docs, least=17).collect()} == {(1, 0, 18, 3)}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == periodic_runs.collapse_runs(docs.limit(0)).count() == 0
