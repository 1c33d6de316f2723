"""Removal of passages that earlier documents have: units of lines are normalised, hashed and grouped over the corpus.

A unit is a line or, in a longer line, a stretch of it between words that the text itself marks (a word whose hash is the
least of its neighbourhood), so a passage falls into the same units wherever in a line it stands. A passage is a sequence of
adjacent units that just reaches enough words, from its first unit on or from its last one back. The earliest occurrence of
a passage, by doc_id and place, stays. Others go; their offsets are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize, scratch

#: A mark is the least of so many words to either side; a unit has so many words at most; a passage has so many at least.
AROUND, LONGEST, LEAST = 3, 64, 20
#: Digests are frequent that occur so often in one of so many parts of the documents; so many of them, at most, are broadcast.
FREQUENT_FROM, PART, FREQUENT = 8, 64, 100_000


def _units(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each unit of the texts: its digest and first word; then the words' bytes and the first word of each text."""
    return _cut(texts)[:-1]


def _cut(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """What _units gives, and the words' hashes."""
    data, bounds = _text.raw(texts)
    low = _text.LOWER[data]
    starts, ends, first = _text.spans(low, bounds, _text.NOT_SPACE)
    words = _text.hashes(low, starts, ends)
    n = len(words)
    text = np.concatenate([_text.owners(first), [-1]])
    mark = np.ones(n, bool)
    for d in range(1, AROUND + 1):  # strictly less than what stands before, so a run of one word has no mark
        near = text[:n][d:] == text[:n][:-d]
        mark[d:] &= ~near | (words[d:] < words[:-d])
        mark[:-d] &= ~near | (words[:-d] <= words[d:])
    newlines = np.flatnonzero(data == 10)
    line = np.searchsorted(newlines, starts)
    mark[1:] |= (line[1:] != line[:-1]) | (text[1:n] != text[: n - 1])
    mark[:1] = True
    at = np.flatnonzero(mark)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    mark |= place % LONGEST == 0
    at = np.flatnonzero(mark)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    power = np.cumprod(np.full(LONGEST, _text._BASE))
    digest = _text.mix(np.add.reduceat(words * power[place], at) + np.diff(np.append(at, n)).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    return digest, at, starts, ends, first, data, bounds, words


def _reach(at: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit: the last unit of the passage that begins with it; and the first of that which ends with it.

    -1 where the text has too few words. A passage that both rules name counts as one that begins with its unit only. Each
    longer sequence of units is a union of such passages.
    """
    stop = np.append(at, n)[1:]
    text = np.searchsorted(first, at, "right") - 1
    ahead = np.where(at + LEAST <= first[text + 1], np.searchsorted(stop, at + LEAST), -1)
    back = np.where(stop - LEAST >= first[text], np.searchsorted(at, stop - LEAST, "right") - 1, -1)
    back[(back >= 0) & (ahead[back] == np.arange(len(at)))] = -1
    return ahead, back


def _lines(at: np.ndarray, starts: np.ndarray, first: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each line that has words, and the last unit of the line that each unit is in."""
    line = np.searchsorted(np.flatnonzero(data == 10), starts[at])
    text = np.searchsorted(first, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    opens = np.flatnonzero(new)
    last = np.append(opens, len(at))[1:] - 1
    return opens, np.repeat(last, np.diff(np.append(opens, len(at))))


def _line_digests(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A digest of the words of each line, whatever its units, unlike those of passages; begin has the lines' first words."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(begin, len(words)))
    place = np.arange(len(words)) - np.repeat(begin, sizes)
    power = np.cumprod(np.full(sizes.max(), _text._BASE))
    return _text.mix(~_text.mix(np.add.reduceat(words * power[place], begin) + sizes.astype(np.uint64)))


def _joint(digest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each sequence of units from begin to end."""
    out = (end - begin).astype(np.uint64)
    for d in range(int((end - begin).max(initial=-1)) + 1):
        on = np.flatnonzero(begin + d <= end)
        out[on] = out[on] * _text._BASE + digest[begin[on] + d]
    return _text.mix(out)


def passages(docs: DataFrame, lines: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), place and digest of every passage; if lines, of every line with words too.

    place is three times the number of the passage's first unit in its text, or three times that of its last unit and one
    more; of a line, three times that of its first unit and two more. Which of them follows from the words, so the places of
    equal passages are in the order of the text. Lines are digested by words, as the units at their ends depend on what
    stands around them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            digest, at, starts, _, first, data, _, words = _cut(piece.column("text"))
            lead = np.searchsorted(at, first)
            ahead, back = _reach(at, first, len(starts))
            a, b = np.flatnonzero(ahead >= 0), np.flatnonzero(back >= 0)
            opens = _lines(at, starts, first, data)[0] if lines else np.zeros(0, np.int64)
            of = _text.owners(lead)[np.concatenate([a, b, opens])]
            place = np.concatenate([a * 3, b * 3 + 1, opens * 3 + 2]) - lead[of] * 3
            digests = np.concatenate([_joint(digest, np.concatenate([a, back[b]]), np.concatenate([ahead[a], b])), _line_digests(words, at[opens]) if lines else np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(of)), piece.column("text_key").take(pa.array(of)), pa.array(place.astype(np.int32)), pa.array(digests.view(np.int64))], names=["doc_id", "text_key", "place", "digest"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(cut, "doc_id long, text_key long, place int, digest long")


def _inside(begin: np.ndarray, end: np.ndarray, total: int) -> np.ndarray:
    """Which of total units lie in one of the sequences from begin to end."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end + 1, -1)
    return np.cumsum(edge)[:total] > 0


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, removed and the text without what was removed; repeated has the places of the passages that others have."""
    for piece in _text.pieces(batches):
        digest, at, starts, ends, first, data, bounds = _units(piece.column("text"))
        lead = np.searchsorted(at, first)
        ahead, back = _reach(at, first, len(starts))
        lists = piece.column("repeated")
        of = np.repeat(np.arange(piece.num_rows), lists.value_lengths().fill_null(0).to_numpy())
        place = lists.flatten().to_numpy()
        unit, kind = lead[of] + place // 3, place % 3
        line_end = _lines(at, starts, first, data)[1]
        flags = _inside(np.where(kind == 1, back[unit], unit), np.choose(kind, [ahead[unit], unit, line_end[unit]]), len(at))
        edge = np.concatenate([[True], flags[1:] != flags[:-1]]) if len(at) else np.zeros(0, bool)
        edge[lead[:-1][np.diff(lead) > 0]] = True  # a run ends with its text
        run = np.flatnonzero(edge)
        gone = np.flatnonzero(flags[run])
        nth = np.append(run, len(at))
        texts, removed, n_removed = piece.column("text").to_pylist(), [[] for _ in range(piece.num_rows)], np.zeros(piece.num_rows, np.int64)
        for g in gone:
            a = at[nth[g]]
            b = at[nth[g + 1]] if nth[g + 1] < len(at) else len(starts)
            k = int(np.searchsorted(first, a, "right")) - 1
            stop = starts[b] if b < first[k + 1] and not (data[ends[b - 1] : starts[b]] == 10).any() else ends[b - 1]
            removed[k].append((starts[a] - bounds[k], stop - bounds[k]))
            n_removed[k] += b - a
        spans = []
        for k, cuts in enumerate(removed):
            if cuts:
                blob = data[bounds[k] : bounds[k + 1]].tobytes()
                chars = np.concatenate([[0], np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)])
                kept = [blob[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(blob)], strict=True)]
                texts[k] = b"".join(kept).decode("utf-8", "replace")
                cuts = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in cuts]
            spans.append(cuts)
        names = [c for c in piece.schema.names if c not in ("text", "repeated")]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(n_removed), pa.array(spans, kind)], names=[*names, "text", "n_words", "n_removed", "removed"])


def _later(found: DataFrame) -> DataFrame:
    """The passages but for the earliest of each digest, by doc_id, place and text_key.

    Digests that some part of the documents show to be frequent are combined before a shuffle and compared where they are; it
    doesn't matter which these are. Of the others, each row is shuffled once.
    """
    at = F.struct("doc_id", "place", "text_key")
    part = found.filter(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PART)) == 0).groupBy("digest").agg(F.count("*").alias("c"))
    hot = materialize(part.filter(F.col("c") >= FREQUENT_FROM).orderBy(F.col("c").desc(), "digest").limit(FREQUENT).select("digest"), "frequent_passages")
    told = found.join(F.broadcast(hot.withColumn("often", F.lit(True))), "digest", "left").filter("often")
    earliest = materialize(told.groupBy("digest").agg(F.min(at).alias("first")), "frequent_passages")
    told = found.join(F.broadcast(earliest), "digest", "left")
    rare = told.filter("first IS NULL").withColumn("first", F.min(at).over(W.partitionBy("digest"))).filter(at != F.col("first"))
    often = told.filter(at != F.col("first"))
    return rare.select("doc_id", "text_key", "place").unionByName(often.select("doc_id", "text_key", "place"))


def _without_repeats(docs: DataFrame, lines: bool) -> DataFrame:
    """The columns of docs but text as c0, c1 and so on; then text (what is left), n_words, n_removed and removed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        found = materialize(passages(rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), lines), "passages")
        later = _later(found).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("repeated"))
        later = materialize(later, "repeated_passages", keep=True)

    names = [(f, "text" if f.name == "text" else f"c{i}") for i, f in enumerate(docs.schema)]
    keyed = docs.toDF(*(x for _, x in names)).withColumns({"doc_id": docs_id(docs, names), "text_key": F.xxhash64("text"), "text": F.col("text").cast("string")})
    joined = keyed.join(later, ["doc_id", "text_key"], "left").drop("doc_id", "text_key")
    schema = ", ".join([*(f"{x} {f.dataType.simpleString()}" for f, x in names if x != "text"), "text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>"])
    return joined.mapInArrow(_cleaned, schema)


def docs_id(docs: DataFrame, names: list) -> F.Column:
    return F.col(next(x for f, x in names if f.name == "doc_id")).cast("long")


def substring_dedup(docs: DataFrame, lines: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed (words), removed (start and end in characters of the original text) and text, as left.

    Words are compared with A-Z lower-cased and without regard to white space. A sequence of units that together have LEAST
    words or more goes where the whole of it occurs earlier, with the blanks after it; so the earliest occurrence of each unit
    always stays, and so do units that are known only from different places. If lines, whole lines that occur earlier as whole
    lines go too, however short; otherwise short repeats stay.

    Null text stays null and loses nothing; so do empty texts. A row without a doc_id has no rank and is left as it is. Rows
    equal in doc_id and text are one document and stay alike; other rows that share a doc_id rank by place, then by a hash of
    their text. No rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _without_repeats(rows, lines).toDF("doc_id", "text", "n_words", "n_removed", "removed")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns and what is left of their texts; n_chars, if there, is that of the text.

    Repeated passages and whole repeated lines go.

    A document of which no word is left is dropped.
    """
    kept = _without_repeats(docs, lines=True).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    out = kept.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), lines=True)


SQL = None
