"""Benchmark decontamination over a positional inverted index of the training documents' words.

The index has a row for each run of documents: its distinct terms, and for each term the positions of its words. A search
takes a phrase's rarest term in the whole index first and intersects the other terms' lists with it, each moved by its
offset in the phrase, from rare to common. Benchmarks go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize, scratch, unused

WINDOW = 10
#: Bytes of document text in an index row, and of benchmark text in a block.
INDEX_BYTES, BLOCK_BYTES = 1 << 19, 1 << 24

INDEX = "doc_ids array<long>, text_keys array<long>, first array<int>, terms binary, counts binary, positions binary"
FOUND = "doc_id long, text_key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, part long, row int"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = _text.raw(texts)
    data = _text.LOWER[data]
    starts, ends, first = _text.spans(data, bounds, _text.ALNUM)
    return _text.hashes(data, starts, ends), first


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index, written to the shared folder: every word of every whole text has a posting.

    A text is known by its doc_id and a hash of it; null text has no postings but its document is in the index.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, limit=INDEX_BYTES):
            words, first = _words(piece.column("text"))
            order = np.argsort(words, kind="stable")
            ranked = words[order]
            new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(ranked)))
            blobs = [x.tobytes() for x in (ranked[new], counts.astype(np.int32), order.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "text_key")] + [pa.array([first.astype(np.int32)], pa.list_(pa.int32()))] + [pa.array([x], pa.binary()) for x in blobs],
                names=["doc_ids", "text_keys", "first", "terms", "counts", "positions"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(index, INDEX), "positional_index").withColumn("part", F.monotonically_increasing_id())


class Phrases:
    """A block's phrases: the terms of each (the vocabulary's indices, in order of offset) and the items it comes from."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words, first = _words(pa.array([x for _, x in items], pa.string()))
        self.vocab, term = np.unique(words, return_inverse=True)
        at, size, item = [], [], []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            n = min(window, b - a)
            if n:
                at.append(np.arange(a, b - n + 1))
                size.append(np.full(b - n + 1 - a, n))
                item.append(np.full(b - n + 1 - a, i))
        self.names = [x for x, _ in items]
        self.size, self.item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, item))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.terms = np.full((len(at), window), -1)
        for j in range(window):
            self.terms[self.size > j, j] = term[at[self.size > j] + j]
        self.order = np.zeros_like(self.terms)

    def rank(self, frequency: np.ndarray) -> None:
        """Order each phrase's offsets from its rarest term to its most common."""
        cost = np.where(self.terms < 0, np.iinfo(np.int64).max, frequency[self.terms])
        self.order = np.argsort(cost, axis=1, kind="stable")


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... for n[0] numbers, then the same for the next."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - lo, n)


def _matches(p: Phrases, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Each match's phrase and first position."""
    at = np.minimum(np.searchsorted(terms, p.vocab), max(0, len(terms) - 1))
    there = terms[at] == p.vocab if len(terms) else np.zeros(len(p.vocab), bool)
    lo, n = np.concatenate([[0], np.cumsum(counts)])[at], np.where(there, counts[at] if len(counts) else 0, 0)
    term_at = np.full(first[-1] + 1, -1)
    term_at[positions[_ranges(lo, n)]] = np.repeat(np.arange(len(p.vocab)), n)
    phrase = np.flatnonzero(((p.terms < 0) | there[p.terms]).all(1))
    offset = p.order[phrase, 0]
    rarest = p.terms[phrase, offset]
    start = positions[_ranges(lo[rarest], n[rarest])].astype(np.int64) - np.repeat(offset, n[rarest])
    phrase = np.repeat(phrase, n[rarest])
    doc = np.searchsorted(first, start + p.order[phrase, 0], "right") - 1
    keep = (start >= first[doc]) & (start + p.size[phrase] <= first[doc + 1])
    phrase, start, doc = phrase[keep], start[keep], doc[keep]
    for j in range(1, p.terms.shape[1]):
        offset = p.order[phrase, j]
        want = p.terms[phrase, offset]
        ok = want < 0
        for move in range(-slop, slop + 1):
            where = start + offset + move
            ok |= (where >= first[doc]) & (where < first[doc + 1]) & (term_at[np.clip(where, 0, first[-1])] == want)
        phrase, start, doc = phrase[ok], start[ok], doc[ok]
    return phrase, start


def search(index: DataFrame, items: list[tuple[str, str]], window: int, slop: int) -> DataFrame:
    """One row for each document of the index: the word ranges that a phrase of the items matches, and those items.

    slop 0 asks for the exact phrase. With slop s a term may stand up to s words off its place, measured from the phrase's
    rarest term; the range is then the phrase's own length.
    """
    context = index.sparkSession.sparkContext
    phrases = Phrases(items, window)
    vocab = context.broadcast(phrases.vocab)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocab.value), len(terms) - 1)
                    total += np.where(terms[at] == vocab.value, counts[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(phrases.vocab), np.int64)
    total[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    phrases.rank(total)
    shared = context.broadcast(phrases)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, keys, first = (batch.column(c)[k].values for c in ("doc_ids", "text_keys", "first"))
                terms, counts, positions = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("terms", np.uint64), ("counts", np.int32), ("positions", np.int32)))
                first = first.to_numpy().astype(np.int64)
                phrase, start = _matches(p, terms, counts, positions, first, slop)
                edge = np.zeros(first[-1] + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + p.size[phrase], -1)
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                hit_at = first[:-1][np.diff(first) > 0]  # a range ends where its document does
                ends_too = np.zeros(len(hit), bool)
                ends_too[hit_at + 1] = True
                begins = np.flatnonzero(hit[1:-1] & (~hit[:-2] | ends_too[1:-1]))
                stops = np.flatnonzero(hit[1:-1] & (~hit[2:] | ends_too[2:])) + 1
                of = np.searchsorted(first, begins, "right") - 1
                n_spans = np.bincount(of, minlength=len(first) - 1)
                pairs = np.unique(np.stack([np.searchsorted(first, start, "right") - 1, p.item[phrase]], 1), axis=0)
                n_items = np.bincount(pairs[:, 0], minlength=len(first) - 1)
                spans = pa.StructArray.from_arrays([pa.array((x - first[of]).astype(np.int32)) for x in (begins, stops)], names=["start", "end"])
                listed = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, keys, pa.array(np.diff(first)), listed(n_spans, spans), listed(n_items, pa.array([p.names[i] for i in pairs[:, 1]], pa.string())), pa.array(np.full(len(first) - 1, batch.column("part")[k].as_py())), pa.array(np.arange(len(first) - 1, dtype=np.int32))],
                    names=["doc_id", "text_key", "n_words", "spans", "items", "part", "row"],
                )

    return index.mapInArrow(find, FOUND)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, the matched word ranges (spans, disjoint, in order) and items.

    An item's phrases are its windows of consecutive words, or all its words if it has fewer. Items without an id or words
    match nothing; items that share an id count as one. Null or empty text: no words, no matches. Null doc_ids and repeated
    rows are rows of their own. No documents give no rows, no items no matches. Other columns are ignored.
    """
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    index = build_index(docs)
    found = None
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = search(index, [tuple(x) for x in block.collect()], window, slop)
        found = rows if found is None else found.unionByName(rows)
    if blocks > 1:
        found = found.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        joined = F.aggregate(
            F.array_sort("spans"),
            F.array().cast("array<struct<start:int,end:int>>"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(done, F.array(x))),
        )
        found = found.withColumn("spans", joined)
    return found.select("doc_id", "text_key", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_phrases() in figures: words in matched windows, items that match, a digest of their ids, and the verdict."""
    found = find_phrases(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs; a null text has none."""
    bad_id, bad_key = unused("bad_id", docs.columns), unused("bad_key", docs.columns)
    with scratch(docs.sparkSession):
        bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
        bad = materialize(bad, "contaminated", keep=True)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    with scratch(spark):
        return materialize(contamination(documents, benchmark).drop("text_key"), "contamination", keep=True)


_WORD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORD} AS w FROM documents),
b AS (SELECT item_id, {_WORD} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
