"""Rows of a live feed by key, in the order of time: the base of the stateful operators.

Rows may come in any order within the watermark's delay. They wait in list state until the watermark has passed them, told by
a timer, and are then handed on by time, whatever batch they came in; rows behind the watermark are dropped by Spark. So
what an operator tells doesn't depend on how the feed falls into batches. A key from which nothing comes for the time of silence
ends: its operator tells what it still holds, and its state goes.

Ordered hands on single rows. Chunked does the same with arrays: what a batch brings of a key is one value in list state, so that
feeds of many wide rows cost calls and conversions by key and batch, not by row.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

#: State that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000
#: Behind the names of columns in state, as a state's column can't have the name of an argument of Row (cls).
_HELD = "__held"


class Ordered(StatefulProcessor):
    """Hands the rows of a key to step(), ordered by `at` (milliseconds) and then by the columns of order."""

    #: Columns that order the rows of a key.
    order: tuple[str, ...] = ("t",)

    def __init__(self, schema: StructType, silence: int = HOUR) -> None:
        self.schema, self.silence = schema, silence

    def init(self, handle) -> None:
        self.row = Row(*(c.removesuffix(_HELD) for c in self.schema.names))
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.seen = handle.getValueState("seen", "at long")
        self.start(handle)

    def start(self, handle) -> None:
        """Open what state the operator has besides."""

    def step(self, key: tuple, rows: list[Row], now: int, ended: bool) -> Iterator[Row]:
        """Handle rows that no earlier one can follow, none when only time went on; ended tells that the key has fallen silent."""
        raise NotImplementedError

    def clear(self) -> None:
        """Forget a key that ended."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.schema.names) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [self.row(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r.at <= now), key=lambda r: (r.at, *(r[c] for c in self.order)))
        left = [r for r in held if r.at > now]
        seen = self.seen.get()[0] if self.seen.exists() else None
        if due:
            if seen is not None:
                self.handle.deleteTimer(seen + self.silence)
            seen = due[-1].at
            self.seen.update((seen,))
            self.handle.registerTimer(seen + self.silence)
            if left:
                self.waiting.put([tuple(r) for r in left])
            else:
                self.waiting.clear()
        ended = not left and seen is not None and now >= seen + self.silence
        yield from self.step(key, due, now, ended)
        if ended:
            self.clear()
            self.seen.clear()
            self.handle.deleteTimer(seen + self.silence)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], processor: type[Ordered], out: str, late: str, *more, silence: int = HOUR) -> DataFrame:
    """A stream of rows (keys, t, ts and others) through a processor by key; ts is the time of the event.

    Rows without a key only move the watermark. The condition names ts, or else it would be applied before the watermark is.
    """
    held = [c for c in rows.columns if c not in (*keys, "ts")]
    feed = rows.withWatermark("ts", late).filter(F.col(keys[0]).isNotNull() | F.col("ts").isNull()).withColumn("at", F.unix_millis("ts")).select(*keys, "ts", "at", *(F.col(c).alias(c + _HELD) for c in held))
    schema = StructType([StructField("at", LongType()), *(feed.schema[c + _HELD] for c in held)])
    return feed.groupBy(*keys).transformWithState(processor(schema, silence, *more), out, "append", "eventTime")


#: Kinds of columns whose nulls are told apart by bits, and what stands in their place: pandas has no nulls in arrays of these.
_PLAIN = {**dict.fromkeys(("tinyint", "smallint", "int", "bigint"), 0), **dict.fromkeys(("float", "double"), 0.0), "boolean": False, "string": ""}


class Chunked(StatefulProcessor):
    """Hands the rows of a key to step() as arrays by column, ordered by `at` (milliseconds) and then by the columns of order.

    The array `nulls` has a bit for each column in which a row is null.
    """

    #: Columns that order the rows of a key.
    order: tuple[str, ...] = ("t",)

    def __init__(self, columns: list[str], bits: dict[str, int], silence: int = HOUR) -> None:
        self.columns, self.bits, self.silence = columns, bits, silence

    def init(self, handle) -> None:
        self.handle, self.handled = handle, None
        self.waiting = handle.getListState("waiting", "rows binary")
        self.next = handle.getValueState("next", "at long")
        self.start(handle)

    def start(self, handle) -> None:
        """Open what state the operator has besides."""

    def step(self, key: tuple, due: dict, left: dict, now: int) -> Generator[pd.DataFrame, None, int | None]:
        """Handle rows that no earlier one can follow; left are those that still wait. Returns when silence is to be looked at, if ever."""
        raise NotImplementedError

    def is_null(self, rows: dict, column: str) -> np.ndarray:
        return (rows["nulls"] >> self.bits[column]) & 1 == 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for chunk in rows:
            chunk.columns = self.columns
            new = {c: chunk[c].to_numpy() for c in self.columns if c != "ts"}
            new["at"] = chunk["at"].astype("int64").to_numpy()
            self.waiting.appendValue((pickle.dumps(new),))
            last = int(new["at"].max()) if last is None else max(last, int(new["at"].max()))
        if last is not None:
            self.handle.registerTimer(last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.handled == (key, now):  # several timers of a key went off: all is done by the first
            return
        self.handled = (key, now)
        chunks = [pickle.loads(x[0]) for x in self.waiting.get()]
        held = joined(chunks) if chunks else {c: np.empty(0, np.int64) for c in self.columns if c != "ts"}
        ready = held["at"] <= now
        due, left = picked(held, ready), picked(held, ~ready)
        due = picked(due, np.lexsort([due[c] for c in (*reversed(self.order), "at")]))
        before = self.next.get()
        until = yield from self.step(key, due, left, now)
        if len(due["at"]):
            if len(left["at"]):
                self.waiting.put([(pickle.dumps(left),)])
            else:
                self.waiting.clear()
        if before is not None and before[0] != until:
            self.handle.deleteTimer(before[0])
        if until is None:
            self.next.clear()
        elif before is None or before[0] != until:
            self.next.update((until,))
            self.handle.registerTimer(until)

    def close(self) -> None:
        pass


def joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]


def picked(rows: dict, which: np.ndarray) -> dict:
    return {c: x[which] for c, x in rows.items()}


def restored(rows: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Rows with their nulls again, without the column nulls."""
    null: dict[str, Column] = {c: F.getbit("nulls", F.lit(b)) == 1 for c, b in bits.items()}
    return rows.select(*(F.when(~null[c], F.col(c)).alias(c) if c in bits else F.col(c) for c in rows.columns if c != "nulls"))


def in_chunks(rows: DataFrame, keys: list[str], processor: type[Chunked], out: StructType | str, late: str, *more, silence: int = HOUR) -> DataFrame:
    """in_order for a Chunked processor. Nulls of columns in its output that it takes over from rows come back by its column nulls, if it has one."""
    held = [c for c in rows.columns if c not in (*keys, "ts")]
    kinds = dict(rows.dtypes)
    bits = {c: k for k, c in enumerate(c for c in held if kinds[c] in _PLAIN)}
    if len(bits) > 63:
        raise ValueError("more than 63 columns")
    nulls = sum((F.shiftleft(F.col(c).isNull().cast("long"), k) for c, k in bits.items()), F.lit(0).cast("long"))
    full = [F.coalesce(c, F.lit(_PLAIN[kinds[c]]).cast(kinds[c])).alias(c) if c in bits else F.col(c) for c in held]
    feed = rows.withWatermark("ts", late).filter(F.col(keys[0]).isNotNull() | F.col("ts").isNull()).select(*keys, "ts", F.unix_millis("ts").alias("at"), nulls.alias("nulls"), *full)
    told = feed.groupBy(*keys).transformWithStateInPandas(processor(feed.columns, bits, silence, *more), out, "append", "eventTime")
    return restored(told, bits) if "nulls" in told.columns else told
