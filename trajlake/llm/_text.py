"""Words of whole texts as numpy arrays, over the UTF-8 bytes of an Arrow batch.

A batch is cut into pieces of about PIECE bytes (a longer text is a piece of its own), so that memory stays in
proportion to the longest text. Words are runs of bytes of a class; the classes used here never split a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_STEP = 1 << 20
#: Bytes hashed at once: their eight-byte values stay in the processor's cache.
_BLOCK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: [^\x20\x09-\x0D]
NOT_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in (_BASE, inverse))


_cached: list = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins (and the last ends); null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to about limit bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = raw(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def spans(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    inside = np.frombuffer(data.tobytes().translate(keep.tobytes()), bool)  # keep[data] without an index of eight bytes for each
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes; spans are in order and don't overlap."""
    longest = max(_BLOCK, int((ends - starts).max(initial=0)))
    if not _cached or len(_cached[0]) <= min(longest, _STEP * 2):  # tables as long as the spans need
        _cached[:] = _powers(min(longest, _STEP * 2))
    power, inverse = _cached
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        piece = data[base : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        if len(piece) > _STEP * 2:  # one span longer than the tables: fold it in steps
            h = np.zeros(1, np.uint64)
            for i in range(0, len(piece), _STEP):
                part = piece[i : i + _STEP]
                h = mix(h + np.sum(part * power[: len(part)], dtype=np.uint64) + np.uint64(len(part)))
            out[at:upto] = h[0]
        else:
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * power[: len(piece)], out=total[1:])
            s, e = starts[at:upto] - base, ends[at:upto] - base
            out[at:upto] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = upto
    return mix(out)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item its text, given the index of each text's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive words, over the whole piece: runs that cross texts are the caller's to drop."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + words[j : j + n]
    return mix(out)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total items lie in one of the runs of length items that begin at starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    return np.cumsum(edge)[:total] > 0


def counted(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
