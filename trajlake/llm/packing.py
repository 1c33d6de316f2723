"""Packing of tokenised documents into sequences by concatenating and cutting.

The first pass tokenises each document once and stores its ids with the tokens before it in its partition. Prefix sums over the
partitions' totals, a row each, then give every document its global place, and fixed windows cut the whole stream; no ids are
shuffled. Where whole sequences are wanted, a task joins the windows that it holds in full, and only the pieces at its borders
are grouped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize, scratch

#: Words whose ids a worker keeps; with more it begins anew.
KNOWN = 2_000_000
SIZE, END_ID = 2048, 1
#: Kinds of bytes: white space, letters of ASCII, other ASCII, all else.
_SPACE, _LETTER, _OTHER, _WIDE = range(4)
_KIND = np.array([_SPACE if b == 0x20 or 0x09 <= b <= 0x0D else _LETTER if chr(b).isalpha() and b < 0x80 else _OTHER if b < 0x80 else _WIDE for b in range(256)], np.int8)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with small letters where the tokenizer can't tell; starts and ends of their words; each text's first word.

    The tokenizer's rules split at white space, and between a letter and a digit or mark, but for what follows an apostrophe.
    What has a "<" in it may be a special token and stays as it is. Composed letters depend on case, so only words all of ASCII
    get small letters.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    before, after = kind[:-1], kind[1:]
    cut[1:] = (before == _LETTER) & (after == _OTHER) | (before == _OTHER) & (after == _LETTER) & (data[:-1] != 0x27)
    starts, ends, first = _text.spans(data, bounds, _KIND != _SPACE)
    special = np.unique(np.searchsorted(starts, np.flatnonzero(data == 0x3C), "right") - 1)
    edge = np.zeros(len(data) + 1, np.int64)
    edge[starts[special]] += 1
    edge[ends[special]] -= 1
    whole = np.cumsum(edge)[:-1] > 0
    cuts = np.flatnonzero(cut & ~whole)
    cuts = cuts[~np.isin(cuts, bounds)] if len(cuts) else cuts
    first = first + np.searchsorted(cuts, bounds)
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    wide = np.concatenate([[0], np.cumsum((kind == _WIDE) | whole)])
    plain = wide[starts] == wide[ends]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts[plain], 1)
    np.add.at(edge, ends[plain], -1)
    return np.where(np.cumsum(edge)[:-1] > 0, _text.LOWER[data], data), starts, ends, first


class Words:
    """Ids of words, each word encoded when it is first met. A text's ids are those of its words, one after another."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.encode, self.end = Tokenizer.from_file(path).encode_batch_fast, end_id
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.array([self.end], np.uint32), np.array([0, 1])  # slot 0 is the end of a text

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = [e.ids for e in self.encode(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        slots = len(self.first) - 1 + np.arange(len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the id at its end, and how many each text has."""
        data, bounds = _text.raw(column)
        data, starts, ends, first = word_spans(data, bounds)
        keys, example, which = np.unique(_text.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KNOWN:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        whole = data.tobytes()
        self._learn(keys[new], [whole[a:b].decode() for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)])
        slot = np.zeros(len(starts) + len(column), np.int64)
        slot[np.arange(len(starts)) + _text.owners(first)] = self.slot[np.searchsorted(self.keys, keys)][which]
        size = np.diff(self.first)[slot]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.diff(after[first[1:] + np.arange(len(column))], prepend=0)


_workers: dict[tuple[str, int], Words] = {}


def _words(path: str, end_id: int) -> Words:
    """Those of this worker, which meets many tasks."""
    return _workers.setdefault((path, end_id), _workers.get((path, end_id)) or Words(path, end_id))


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (32-bit, little-endian), tokens (their number), part, and before, the tokens before it in this part.

    Read it through materialize(): each row then belongs to the one attempt of its task that was kept.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = _words(path, end_id), TaskContext.get().partitionId(), 0
        for piece in _text.pieces(batches):
            ids, size = words.texts(piece.column("text"))
            bounds = np.concatenate([[0], np.cumsum(size)])
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
            columns = [piece.column("doc_id"), blob.cast(pa.binary()), pa.array(size), pa.array(np.full(len(size), part, np.int32)), pa.array(before + bounds[:-1])]
            before += int(bounds[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "tokens", "part", "before"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(each, "doc_id long, ids binary, tokens long, part int, before long")


def _windows(total: int, size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Where the whole windows end, and number, begin and end of those after: the rest cut into powers of two, which need no padding."""
    whole = total - total % size
    at, out = whole, []
    for bit in reversed(range(size.bit_length())):
        if (total - whole) >> bit & 1:
            out.append((whole // size + len(out), at, at + (1 << bit)))
            at += 1 << bit
    return whole, out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, and sequence_tokens, the whole sequence's length.

    All sequences have size tokens; what is left at the end makes up to eleven more (for 2048), each a power of two long.
    The order is that of the rows in the table's files. Null or empty text has end_id alone, and so makes a piece; a null doc_id
    is a document like any other, and so is a repeated row. No rows give no rows; other columns are ignored. A document's ids
    are one value, so memory follows the longest document.
    """
    table = materialize(tokenize(docs, path or public_tokenizers.path("word_bpe_49k.json"), end_id), "packed_ids")
    # A row for each task of the first pass, so the window over all of it is small, and so is the broadcast.
    parts = table.groupBy("part").agg(F.sum("tokens").alias("held"))
    total = parts.agg(F.sum("held")).first()[0] or 0
    parts = parts.select("part", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("ahead"))
    whole, last = _windows(total, size)
    placed = table.join(F.broadcast(parts), "part").withColumn("at", F.col("ahead") + F.col("before"))
    placed = placed.withColumn("to", F.col("at") + F.col("tokens"))
    kind = "array<struct<id:bigint,lo:bigint,hi:bigint>>"
    numbers = F.sequence(F.expr(f"at div {size}"), F.expr(f"(least(to, {whole}) - 1) div {size}"))
    windows = F.when(F.col("at") < whole, F.transform(numbers, lambda k: F.struct(k.alias("id"), (k * size).alias("lo"), (k * size + size).alias("hi")))).otherwise(F.array().cast(kind))
    rest = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(w, ("id", "lo", "hi"), strict=True))) for w in last)).cast(kind)
    windows = F.concat(windows, F.filter(rest, lambda w: (w["lo"] < F.col("to")) & (w["hi"] > F.col("at"))))

    def piece(w):
        lo, hi = F.greatest(w["lo"], "at"), F.least(w["hi"], "to")
        ids = F.substring("ids", ((lo - F.col("at")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int"))
        return F.struct((lo - F.col("at")).alias("start"), (hi - lo).alias("length"), ids.alias("ids"), w["id"].alias("sequence_id"), (lo - w["lo"]).alias("offset"), (w["hi"] - w["lo"]).alias("sequence_tokens"))

    # The pieces are made before they are rows, so that no row carries a document's ids once more.
    rows = placed.select("doc_id", F.col("tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return rows.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "p.sequence_tokens")


_PIECE = "struct<doc_id:bigint,start:bigint,offset:bigint,length:bigint>"


def sequences(pieces: DataFrame) -> DataFrame:
    """From the rows of pack(): sequence_id, ids (array of int) and pieces (doc_id, start, offset, length), by offset.

    What a task holds of a sequence in full is joined there; other pieces, those at the borders of tasks, are grouped.
    """
    schema = f"sequence_id long, at long, sequence_tokens long, ids binary, pieces array<{_PIECE}>"

    def each(batches):
        held: list[dict] = []

        def told(rows):
            return {
                "sequence_id": rows[0]["sequence_id"], "at": rows[0]["offset"], "sequence_tokens": rows[0]["sequence_tokens"], "ids": b"".join(r["ids"] for r in rows),
                "pieces": [{k: r[k] for k in ("doc_id", "start", "offset", "length")} for r in rows],
            }

        def follows(r):
            return held and held[-1]["sequence_id"] == r["sequence_id"] and held[-1]["offset"] + held[-1]["length"] == r["offset"]

        kinds = pa.schema([("sequence_id", pa.int64()), ("at", pa.int64()), ("sequence_tokens", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_id", "start", "offset", "length")])))])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and not follows(r):
                    out.append(told(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if held:
            yield pa.RecordBatch.from_pylist([told(held)], kinds)

    joined = pieces.mapInArrow(each, schema)
    full = F.octet_length("ids") == 4 * F.col("sequence_tokens")
    border = joined.filter(~full).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "pieces"))).alias("p"))  # of sequence_tokens ids at most
    border = border.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.flatten("p.pieces").alias("pieces"))
    every = joined.filter(full).select("sequence_id", "ids", "pieces").unionByName(border).withColumn("hex", F.hex("ids"))
    number = lambda k: F.conv(F.concat(*(F.substring("hex", k * 8 + at, F.lit(2)) for at in (7, 5, 3, 1))), 16, 10).cast("int")
    return every.select("sequence_id", F.transform(F.sequence(F.lit(0), F.expr("int(octet_length(ids) div 4 - 1)")), number).alias("ids"), "pieces")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"), "packed_pieces", keep=True)


#: SQL has no tokenizer; tests hold the result against a plain version and read all documents back from the sequences.
SQL = None
