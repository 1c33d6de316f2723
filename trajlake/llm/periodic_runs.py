"""Periodic runs of words, found through string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q, at least 2 q long, that no neighbouring word extends. At scale t a set of
positions is chosen by the hash of what stands there alone: i is in it if the least hash of the windows of t words that begin at
i to i + t is the first's or the last's, windows of a period of t / 3 or less apart. Equal contexts of 2 t words are so chosen
alike, and unless the 3 t - 1 words at a place have such a small period, one of the t positions from there is chosen. Therefore a
run with 3 t - 1 <= q < 6 t - 1 holds two chosen positions with equal contexts q apart, which propose it, unless its first q words
or more lie in a highly periodic region. Such regions are the runs of smaller scales; two of them with one period that meet supply
the periods left out. Periods below the first scale are found by comparing words directly. Each proposal is extended to both sides
by comparing blocks of 2^k words, whose hashes come from those of their halves, and only stretches of 2 q words or more are runs.

A batch of documents is one sequence of words, each text ended by a word that occurs nowhere else.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text

#: The first scale; periods below 3 FIRST - 1 are compared directly.
FIRST = 4
_LEFT, _RIGHT, _END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Blocks:
    """Hashes of all blocks of 2^k words, and how far two places agree."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.n, self.hashes = len(words), [words]
        while (size := 1 << len(self.hashes)) <= min(longest, self.n):
            halves = self.hashes[-1]
            self.hashes.append(_text.mix(halves[: -size // 2] * _LEFT + _text.mix(halves[size // 2 :] + _RIGHT)))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, a being before b; no more than the longest text has."""
        same = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.hashes))):
            able = np.flatnonzero(b + same + (1 << k) <= self.n)
            i, j = (a + same)[able], (b + same)[able]
            same[able[self.hashes[k][i] == self.hashes[k][j]]] += 1 << k
        return same

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words right before a equal those right before b."""
        same = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.hashes))):
            able = np.flatnonzero(a - same - (1 << k) >= 0)
            i, j = (a - same)[able] - (1 << k), (b - same)[able] - (1 << k)
            same[able[self.hashes[k][i] == self.hashes[k][j]]] += 1 << k
        return same


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in self))


def _distinct(*found: Runs) -> Runs:
    """Each stretch once, with its smallest period, by start and end."""
    every = Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    every = every.take(np.lexsort(every[::-1]))
    again = (every.start[1:] == every.start[:-1]) & (every.end[1:] == every.end[:-1])
    return every.take(np.concatenate([[True], ~again])[: len(every.start)])


def _direct(words: np.ndarray, period: int) -> Runs:
    """Maximal stretches in which words that stand period apart are equal, of two periods or more."""
    same = np.zeros(len(words) + 2, np.int8)
    same[1 : len(words) - period + 1] = words[:-period] == words[period:]
    edge = np.diff(same)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + period
    long = end - start >= 2 * period
    return Runs(start[long], end[long], np.full(np.count_nonzero(long), period))


def _extended(blocks: Blocks, at: np.ndarray, period: np.ndarray) -> Runs:
    """The runs that the proposals lie in: a place and the period that holds from there."""
    start, end = at - blocks.behind(at, at + period), at + period + blocks.ahead(at, at + period)
    return Runs(start, end, period).take(end - start >= 2 * period)


def synchronising(blocks: Blocks, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The chosen positions at a scale (a power of two), given where windows of scale words have a small period."""
    k = scale.bit_length() - 1
    key = _text.mix(blocks.hashes[k] ^ _END)
    key[periodic[: len(key)]] = _NONE
    least = key
    for j in range(k):  # the least of 2, 4, ... scale windows
        least = np.minimum(least[: -(1 << j)], least[1 << j :])
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != _NONE) & ((least == key[: len(least)]) | (least == key[scale : scale + len(least)])))


def _equal_contexts(blocks: Blocks, scale: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of chosen positions with equal contexts, 3 scale - 1 to 6 scale - 2 words apart.

    Equal contexts stand more than scale / 3 apart, since theirs is no small period, so a position has 18 partners at most.
    """
    context = blocks.hashes[scale.bit_length()][chosen]
    order = np.argsort(context, kind="stable")
    context, chosen = context[order], chosen[order]
    at, apart, left = [], [], np.arange(len(chosen))
    for lag in count(1):
        left = left[left + lag < len(chosen)]
        far = chosen[left + lag] - chosen[left]
        near = (context[left + lag] == context[left]) & (far < 6 * scale - 1)
        left, far = left[near], far[near]
        if not len(left):
            break
        at.append(chosen[left[far >= 3 * scale - 1]])
        apart.append(far[far >= 3 * scale - 1])
    return (np.concatenate(at), np.concatenate(apart)) if at else (np.zeros(0, np.int64),) * 2


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many items each: whose they are, and their numbers from 0."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _meeting_regions(blocks: Blocks, scale: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of runs made of two highly periodic regions of one period that touch or overlap.

    A word of the first region equals the one a period further, in the second, so the periods are one rest modulo that of the
    regions: the rest at which the words of the first region's start turn up in the second.
    """
    size = runs.end - runs.start
    long = runs.take((3 * runs.period <= scale) & (size >= 3 * scale - 1))
    long = long.take(np.lexsort((long.start, long.period)))
    meet = np.flatnonzero((long.period[1:] == long.period[:-1]) & (long.start[1:] <= long.end[:-1]) & (long.start[1:] > long.start[:-1]))
    first, second, p = long.take(meet), long.take(meet + 1), long.period[meet]
    of, turn = _each(p)
    fits = blocks.ahead(first.start[of], second.start[of] + turn) >= p[of]
    of, turn = of[fits], turn[fits]
    first, second, p = first.take(of), second.take(of), p[of]
    rest = (second.start + turn - first.start) % p
    most = np.minimum.reduce([first.end - first.start, second.end - second.start, (second.end - first.start) // 2, np.full(len(p), 6 * scale - 2)])
    least = 3 * scale - 1 + (rest - (3 * scale - 1)) % p
    of, step = _each(np.maximum(0, (most - least) // np.maximum(p, 1) + 1))
    period = least[of] + step * p[of]
    return np.maximum(first.start[of], second.start[of] - period), period


def find_runs(words: np.ndarray, longest: int) -> Runs:
    """All runs in a sequence of word hashes, however short, by start and end; none is longer than longest."""
    words = np.ascontiguousarray(words)
    runs = _distinct(*(_direct(words, q) for q in range(1, min(3 * FIRST - 1, len(words)))), Runs(*(np.zeros(0, np.int64),) * 3))
    blocks, scale = Blocks(words, longest), FIRST
    while 2 * (3 * scale - 1) <= longest:
        small = runs.take((3 * runs.period <= scale) & (runs.end - runs.start >= scale))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, small.start, 1)
        np.add.at(edge, small.end - scale + 1, -1)
        chosen = synchronising(blocks, scale, np.cumsum(edge) > 0)
        proposed = [_equal_contexts(blocks, scale, chosen), _meeting_regions(blocks, scale, runs)]
        at, period = (np.concatenate(x) for x in zip(*proposed, strict=True))
        if len(at):
            runs = _distinct(runs, _extended(blocks, at, period))
        scale *= 2
    return runs


class Found(NamedTuple):
    """A piece of documents: its runs of the wanted length, by text and place; which words stay; the text without the others."""

    ids: pa.Array
    text: np.ndarray  # of each run
    start: np.ndarray  # the word's number in its text
    length: np.ndarray
    period: np.ndarray
    kept: list[bytes]


def _search(batches: Iterator[pa.RecordBatch], least: int, rewrite: Callable | None) -> Iterator[Found]:
    for piece in _text.pieces(batches):
        data, bounds = _text.raw(piece.column("text"))
        starts, ends, first = _text.spans(data, bounds, _text.NOT_SPACE)
        word = np.arange(len(starts))
        if rewrite:
            for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                word[first[k] : first[k + 1]] = first[k] + rewrite(doc, int(first[k + 1] - first[k]))
        begin = first + np.arange(len(first))  # where each text's words begin, when each text is followed by one more word
        place = np.arange(len(word)) + _text.owners(first)
        line = _text.mix(np.arange(begin[-1], dtype=np.uint64) + _END)
        line[place] = _text.hashes(data, starts, ends)[word]
        runs = find_runs(line, int(np.diff(first).max()))
        runs = runs.take(runs.end - runs.start >= np.maximum(least, 2 * runs.period))

        edge = np.zeros(len(line) + 1, np.int64)
        np.add.at(edge, runs.start + runs.period, 1)
        np.add.at(edge, runs.end, -1)
        stays = np.cumsum(edge)[place] == 0
        word, of = word[stays], _text.owners(first)[stays]
        size = ends[word] - starts[word] + 1  # with the space behind it
        after = np.cumsum(size)
        joined = data[np.minimum(np.repeat(starts[word] - after + size, size) + np.arange(after[-1] if len(after) else 0), max(0, len(data) - 1))]
        joined[after - 1] = 0x20
        cut = np.concatenate([[0], after])[np.searchsorted(of, np.arange(len(first)))]
        whole = joined.tobytes()
        text = np.searchsorted(begin, runs.start, "right") - 1
        yield Found(
            piece.column("doc_id"), text, runs.start - begin[text], runs.end - runs.start, runs.period,
            [whole[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)],
        )


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """One row per run of least words or more: doc_id, start (number of its first word), length, period.

    Null or empty text has no runs, hence no row. A null doc_id is a row like any other; repeated rows give repeated runs; no
    documents give no rows; other columns are ignored. A text is handled as a whole: memory follows the longest one.
    """

    def each(batches):
        for x in _search(batches, least, None):
            yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(x.text)), *map(pa.array, (x.start, x.length, x.period))], ["doc_id", "start", "length", "period"])

    return _read(docs).mapInArrow(each, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id and collapsed, the text's words joined by one space, less what any run has after its first period.

    Null or empty text: the empty text. Null doc_ids, repeated rows, other columns and no rows: as for periodic_runs().
    """

    def each(batches):
        for x in _search(batches, least, None):
            yield pa.RecordBatch.from_arrays([x.ids, pa.array([t.decode() for t in x.kept], pa.string())], ["doc_id", "collapsed"])

    return _read(docs).mapInArrow(each, "doc_id long, collapsed string")


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, least: int = 12, rewrite: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """One row per document: how many runs, the longest one (nulls without any), digests of all runs and of the collapsed text.

    rewrite gives, from a doc_id and a number of words, the number of the word that stands at each place. Null or empty text: no
    runs, and digests of the empty text. Null doc_ids, repeated rows, other columns and no rows: as for periodic_runs().
    """

    def each(batches):
        for x in _search(batches, least, rewrite):
            rows = np.split(np.lexsort((x.period, x.start, x.text)), np.cumsum(np.bincount(x.text, minlength=len(x.ids)))[:-1])
            out = []
            for mine, text in zip(rows, x.kept, strict=True):
                found = list(zip(x.start[mine].tolist(), x.length[mine].tolist(), x.period[mine].tolist(), strict=True))
                best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                out.append((len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = [*[pa.int64()] * 5, *[pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([x.ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [c.split()[0] for c in DIGESTS.split(", ")])

    return _read(docs).mapInArrow(each, DIGESTS)


def looped(doc_id: int | None, n: int) -> np.ndarray:
    """The query's texts: in one of ten, by a hash of the id, the words from some place on go round in a loop."""
    word = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        word[a:] = a + (word[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return word


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=looped)


#: The loops need crc32, which SQL lacks; tests hold the result against brute force.
SQL = None
